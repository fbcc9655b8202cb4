"""DataFrame transformations of the record-linkage dataflow."""
