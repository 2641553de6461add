"""Writers of graphs, checkers and reports."""
