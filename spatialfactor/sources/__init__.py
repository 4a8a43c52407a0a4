"""Reading and writing data sets and results."""
