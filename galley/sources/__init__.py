"""Tables in and out: catalog, files, literal rows, generators."""
