"""Part of loamdex; see README.md."""
