"""Column functions: text, paths, credentials, source code. All of them are Column -> Column and stay in one row."""
