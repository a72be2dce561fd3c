"""Every operator as a query over the test tables, with the SQL that gives the same result where SQL can."""
