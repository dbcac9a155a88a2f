"""segloom: a PySpark engine for scoring and preparing translation segments at scale."""
