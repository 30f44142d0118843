"""Plans over the test tables: each registered query and the SQL that must give the same rows."""
