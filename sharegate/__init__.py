"""sharegate: decide at corpus scale what text and files are safe to share."""
