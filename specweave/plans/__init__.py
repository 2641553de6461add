"""Whole flows: build a graph, plan and assert, answer a question, analyse results."""
