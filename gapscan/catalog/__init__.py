"""Every operator as a query on the test tables, with independent SQL to compare to."""
