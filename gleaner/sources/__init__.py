"""Files, tables and the adapters that present other tables as files."""
