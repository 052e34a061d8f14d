"""Part of quillmask; see README.md."""
