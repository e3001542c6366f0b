"""Every operator as a query on the supplied tables, with the same result in SQL."""
