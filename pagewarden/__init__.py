"""Website audits as Spark DataFrames: parsing, rules, link graph, extraction, reports."""
