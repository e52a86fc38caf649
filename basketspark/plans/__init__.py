"""The library's operators applied to the test tables, each with SQL of the same result."""
