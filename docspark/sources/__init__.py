"""Where collections come from: the catalog, files and system collections."""
