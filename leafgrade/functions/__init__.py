"""Column functions: tokens, page signals, text transforms, diagnostics."""
