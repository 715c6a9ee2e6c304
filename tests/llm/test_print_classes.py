"""Crowds that share keys: rows and links grow with the members, classes are those of all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from sharegate.llm import edit_sketch


def _crowd(n, seed, own=(10, 60)):
    """Prints around one base; the first band pair is the base's in all of them."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 256, 128).astype(np.uint8)
    kept = [s for band in edit_sketch.band_pairs(0.8)[0] for s in range(4 * band, 4 * band + 4)]
    free, out = np.setdiff1d(np.arange(128), kept), np.tile(base, (n, 1))
    for p in out:
        at = rng.choice(free, rng.integers(*own), replace=False)
        p[at] ^= rng.integers(1, 4, len(at)).astype(np.uint8)
    return np.unique(out, axis=0)


def _labels(n, links):
    label = list(range(n))
    for _ in range(n):
        was = list(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == was:
            return label


def _all_links(prints):
    return [(a, int(b)) for a, p in enumerate(prints) for b in np.flatnonzero((prints == p).mean(axis=1) >= 0.8) if a < b]


@pytest.mark.parametrize("own", [(10, 60), (12, 30), (80, 110), (0, 3)])
def test_forest_links_as_all_pairs_do(own):
    prints = _crowd(250, 3, own)
    links = edit_sketch._forest(prints, 103)
    assert _labels(len(prints), links) == _labels(len(prints), _all_links(prints))
    assert len(links) == len(prints) - len(set(_labels(len(prints), links))) and set(links) <= {x for a, b in _all_links(prints) for x in ((a, b), (b, a))}


@pytest.mark.parametrize("most, rows", [(1000, 400), (200, 400), (100, 400 * 3), (64, 400 * 6)])
def test_a_crowd_is_cut_into_tiles_where_all_members_meet(most, rows):
    prints = np.random.default_rng(1).integers(0, 256, (400, 128)).astype(np.uint8)
    pair = edit_sketch.band_pairs(0.8)[0]
    prints[:, [s for band in pair for s in range(4 * band, 4 * band + 4)]] = 7
    nodes = pa.RecordBatch.from_pydict({"nid": pa.array(range(400), pa.int64()), "fingerprint": [p.tobytes() for p in prints]})
    keys = list(edit_sketch._key_blobs([pair], 1)([nodes]))
    out = pa.Table.from_batches(edit_sketch._tiles(most)(keys)).to_pydict()
    tiles = {}
    for t, n in zip(out["tile"], out["nid"], strict=True):
        tiles.setdefault(t, set()).add(n)
    assert sum(map(len, tiles.values())) == rows == len(out["nid"]) and max(map(len, tiles.values())) <= 2 * most
    assert len({(a, b) for t in tiles.values() for a in t for b in t}) == 400 * 400


def test_classes_do_not_depend_on_the_size_of_tiles(spark):
    prints = np.concatenate([_crowd(200, 5), _crowd(60, 6, (12, 30)), np.random.default_rng(2).integers(0, 256, (40, 128)).astype(np.uint8)])
    rows = [(None if i == 3 else i, bytearray(p.tobytes())) for i, p in enumerate(prints)]
    df = spark.createDataFrame([*rows, *rows[:50]], "doc_id long, fingerprint binary")
    label = _labels(len(prints), _all_links(prints))
    want = {bytes(f): min((j for j, x in enumerate(label) if x == label[i] and j != 3), default=None) for i, (_, f) in enumerate(rows)}
    for tile in (5, 1 << 14):
        got = edit_sketch.print_classes(df, tile=tile).collect()
        assert len(got) == len(prints) and {bytes(r.fingerprint): r.class_id for r in got} == want
