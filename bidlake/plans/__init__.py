"""Plans over the driver's tables: each operator as a query with SQL that says the same."""
