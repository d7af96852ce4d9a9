"""Jobs that chain operators, and the query catalogue over the test tables."""
