"""SQL twins of the registered queries, written independently of the plans."""
