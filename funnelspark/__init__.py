"""funnelspark: clickstream cleaning, labelling, features, scoring and reporting as Spark DataFrames."""
