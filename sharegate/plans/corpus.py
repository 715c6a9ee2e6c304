"""Test corpora derived from the driver tables, as SQL both Spark and DuckDB read.

No credential rule fires on the raw tables, so texts get a seed behind them, chosen by the
row's number. Seeds are written as recipes and never as finished tokens. Every row of the
table is kept, with its whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BS, DQ, NL, ZWSP = "chr(92)", "chr(34)", "chr(10)", "\u200b"

# slot -> SQL recipe; slots not listed append nothing
SEEDS = {
    0: "'31415926' || ':A' || repeat('Ax', 17)",
    1: "'gl' || 'pat-' || repeat('b7', 10)",
    2: "'xo' || 'xa-' || repeat('5', 12)",
    3: "'hf' || '_' || repeat('Zz', 17)",
    4: "'AI' || 'za' || repeat('pQ_r5', 7)",
    5: "'AS' || 'IA' || repeat('7KQM', 4)",
    6: "'rk_' || 'test_' || repeat('yY3', 9)",
    7: "'gh' || 'o_' || repeat('Gh1', 12)",
    8: "'np' || 'm_' || repeat('pN6', 12)",
    9: "'pypi-' || 'AgEIcHlwaS5vcmc' || repeat('w_', 25) || 'w'",
    10: "'SG.' || repeat('s2', 11) || '.' || repeat('t', 43)",
    11: "'sk' || '-ant-' || repeat('cd9', 10)",
    12: "'-----BEGIN OPENSSH ' || 'PRIVATE KEY-----'",
    13: "'sk' || '-proj-' || repeat('oP4i', 9)",
    14: "'PuTTY-User-' || 'Key-File-3'",
    15: "'ey' || 'J' || repeat('h5', 8) || '.ey' || 'J' || repeat('p6', 9) || '.' || repeat('s7', 7)",
    16: f"'{{' || {DQ} || 'auths' || {DQ} || ' : {{ }}}}'",
    17: "'printer at 192.168.77.5 is out of paper'",
    18: f"'api' || '-key: ' || {DQ} || 'open-sesame-42' || {DQ}",
    19: "'label says 3E-1 or 3e:1f:aa:09:7b:c4'",
    20: f"'AWS_SECRET_' || 'ACCESS_KEY : ' || {DQ} || repeat('zX8/', 10) || {DQ}",
    21: "'github' || '_pat_' || repeat('f_3', 21)",
    22: "'tailnet node 100.77.8.9 joined'",
    23: "'mysql://reader:' || 'letmein9@db.example/stock'",
    24: "'bind to fd77:1:2:3:4:5:6 first'",
    25: f"'drawings on ' || {BS} || {BS} || 'nas-02' || {BS} || 'plans'",
    26: f"'saved below E:' || {BS} || 'Users' || {BS} || 'm.novak'",
    27: "'ask grafana.lan for the graphs'",
    28: f"'Host gate' || {NL} || '   HostName gate.example'",
    29: "'mounted /Users/m.novak/photos/raw'",
    30: "'172.18.0.4 had ' || 'AK' || 'IA' || repeat('9B', 8) || ' beside ' || 'gh' || 'r_' || repeat('k1', 18)",
    31: "'built in /home/runner/work'",
    37: f"'AC{ZWSP}' || 'CA' || repeat('2W', 8)",
}
# Quick-scan seeds: the same tokens hidden in base64 and hex, per engine.
QUICK_SEEDS = {
    3: "{b64}'key AK' || 'IA' || repeat('Q', 16){end}",
    5: "'AK' || 'IA' || repeat('A', 12)",
    7: "lower({hex}'note sk-' || repeat('Z', 20){end})",
    11: "'host a1.corp.' || 'internal'",
    13: "'BEGIN RSA ' || 'PRIVATE KEY'",
    17: "{b64}'nothing to see in this plain text'{end}",
}
AUTHOR_SEEDS = {
    0: f"{NL} || 'maintained by sam@example.com' || {NL} || 'number 219-09-9999'",
    1: f"{NL} || '(c) Sam Roe <sam@example.com> 604-555-0182'",
    2: f"{NL} || 'orders: shop@example.com, 604 555 0182' || {NL}",
    3: "'paid with 5500 0000 0000 0004, press@example.com'",
}
BASES = {0: "'.env'", 1: "'server.pem'", 2: "'id_rsa'", 3: "'.env.example'", 4: "'notes.bak'", 5: "'dump.sql'"}
DIRS = {1: "'node_modules'", 2: "'.ssh'", 3: "'logs'", 4: "'docs/Build'", 5: "'docs'", 6: "'src/my_venv/lib'",
        7: "'src/pkg'", 8: "'.github/workflows'", 9: "'logs/old'"}
IGNORE_ROOT = ["# build output", "*.bak", "logs/", "**/server.pem", "!docs/**/server.pem", "/src/pkg/d7*", "!dump.sql"]
IGNORE_DOCS = ["id_rsa", ".env"]


def pick(key: str, size: int, options: dict[int, str], default: str) -> str:
    cases = " ".join(f"WHEN {k} THEN {v}" for k, v in options.items())
    return f"(CASE {key} % {size} {cases} ELSE {default} END)"


def seeded_text(column: str, key: str) -> str:
    return f"{column} || ' ' || {pick(key, 41, SEEDS, chr(39) * 2)} || ' '"


def _name(key: str) -> str:
    doc = f"'doc_' || cast({key} AS varchar(20)) || '.md'"
    return pick(key, 16, BASES, doc)


FLAT = (f"SELECT doc_id, source AS share_id, source || '/d' || cast(doc_id AS varchar(20)) || '/' || {_name('doc_id')} "
        f"AS path, {seeded_text('text', 'doc_id')} AS text FROM documents")
PLAIN = ("SELECT doc_id, source AS share_id, source || '/doc_' || cast(doc_id AS varchar(20)) || '.md' AS path, text "
         "FROM documents")
TREE = (f"SELECT doc_id, source AS share_id, {pick('doc_id', 11, DIRS, chr(39) + 'src' + chr(39))} || '/d' || "
        f"cast(doc_id AS varchar(20)) || '/' || {_name('doc_id')} AS path, {seeded_text('text', 'doc_id')} AS text "
        "FROM documents")


def _ignore_file(path: str, lines: list[str]) -> str:
    body = f" || {NL} || ".join(f"'{x}'" for x in lines)
    return f"SELECT DISTINCT cast(-1 AS bigint) AS doc_id, source AS share_id, '{path}' AS path, {body} AS text FROM documents"


TREE_WITH_IGNORES = f"{TREE} UNION ALL {_ignore_file('.gitignore', IGNORE_ROOT)} UNION ALL {_ignore_file('docs/.gitignore', IGNORE_DOCS)}"
CONVERSATIONS = (f"SELECT conv_id, turn, role AS share_id, 'conv/' || cast(conv_id AS varchar(20)) || '/' || "
                 f"cast(turn AS varchar(20)) || '.txt' AS path, {seeded_text('text', 'conv_id + turn')} AS text "
                 "FROM conversations")
# URL path as file path; a page without one is the host's index
PAGES = ("SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS share_id, "
         f"regexp_extract(url, '^https?://[^/?#]+/([^?#]*)', 1) AS path, {seeded_text('html', 'page_id')} AS html FROM pages")
AUTHORS = (f"SELECT doc_id, source AS share_id, source || '/doc_' || cast(doc_id AS varchar(20)) || '.md' AS path, "
           f"text || {pick('doc_id', 7, AUTHOR_SEEDS, chr(39) * 2)} AS text FROM documents")


UNREADABLE = (f"SELECT doc_id, share_id, path, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE text END AS text FROM ({PLAIN})")
# every text names a private address; shares are numbered by their names
LOCAL_TEXTS = ("SELECT share_id, cast(substring(share_id, 4) AS int) AS share_no, path, text || ' printer at 192.168.77.5 ' AS text "
               f"FROM ({PLAIN})")
LONG = (f"SELECT share_id, path, CASE WHEN doc_id % 499 = 7 THEN text || repeat(' lorem ipsum', 360000) || ' AS' || 'IA' || repeat('7KQM', 4) || "
        f"repeat(' dolor sit a', 360000) ELSE text END AS text FROM ({PLAIN})")
def _two_ignore_files() -> str:
    numbered = "source AS share_id, cast(substring(source, 4) AS int) AS share_no"
    docs = f"SELECT {numbered}, 'k' || cast(doc_id % 5 AS varchar(20)) || '/doc_' || cast(doc_id AS varchar(20)) || '.md' AS path, text FROM documents"
    rules = {".gitignore": "'*7.md'", ".shareignore": f"'!*27.md' || {NL} || 'k3/'"}
    return docs + "".join(f" UNION ALL SELECT DISTINCT {numbered}, '{name}' AS path, {body} AS text FROM documents" for name, body in rules.items())


TWO_IGNORES = _two_ignore_files()
AREAS = ("SELECT source AS share_id, 'area/a' || cast(doc_id % 3 AS varchar(20)) || '/b' || cast(doc_id % 5 AS varchar(20)) || '/doc_' || "
         "cast(doc_id AS varchar(20)) || '.md' AS path, text FROM documents")


def many_runs(b64: str, end: str) -> str:
    """Every seventh document ends in a hidden token behind 300 harmless runs."""
    noise = f"repeat({b64}'nothing to see in this plain text'{end} || ' ', 300)"
    return ("SELECT doc_id, source AS share_id, source || '/doc_' || cast(doc_id AS varchar(20)) || '.md' AS path, CASE WHEN doc_id % 7 = 0 THEN "
            f"text || ' ' || {noise} || {b64}'key AK' || 'IA' || repeat('Q', 16){end} ELSE text END AS text FROM documents")


MANY_SPARK, MANY_DUCKDB = many_runs("base64(", ")"), many_runs("to_base64(encode(", "))")


def quick_corpus(b64: str, hex_: str, end: str) -> str:
    seeds = {k: v.format(b64=b64, hex=hex_, end=end) for k, v in QUICK_SEEDS.items()}
    return (f"SELECT doc_id, source AS share_id, source || '/d' || cast(doc_id AS varchar(20)) || '/' || {_name('doc_id')} "
            f"AS path, text || ' ' || {pick('doc_id', 19, seeds, chr(39) * 2)} || ' ' AS text FROM documents")


QUICK_SPARK = quick_corpus("base64(", "hex(", ")")
QUICK_DUCKDB = quick_corpus("to_base64(encode(", "hex(encode(", "))")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Run corpus SQL over the given tables (default: documents)."""
    names = tables or ("documents",)
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(f"sharegate_{name}")
    for name in names:
        sql = sql.replace(f"FROM {name}", f"FROM sharegate_{name}")
    return spark.sql(sql)
