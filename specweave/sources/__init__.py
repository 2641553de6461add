"""Scans of documents, Verilog, GraphML and result files."""
