"""DataFrame operators: documents, facts, links, graph, reports."""
