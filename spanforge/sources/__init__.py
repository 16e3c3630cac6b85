"""Where relations come from: derived catalogs, chunk files, byte ranges."""
