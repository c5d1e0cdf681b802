"""Tables in, tables out: fixed schemas, scans, staged tables and append-only sinks."""
