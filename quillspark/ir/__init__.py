"""Parsing of notebook cells: dataflow graphs, symbols, file access, syntax trees."""
