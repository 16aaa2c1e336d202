"""Part of lexspan; see README.md."""
