"""The warehouse queries: DataFrame plans over the operators, and the SQL that gives the same rows."""
