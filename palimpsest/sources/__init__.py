"""Storage on any Hadoop file system: files, the commit log, write-ahead batches and sorted Parquet runs."""
