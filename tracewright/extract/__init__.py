"""Facts out of texts: table-valued functions over files and SQL."""
