"""Named queries over the tables, each with the SQL it must agree with."""
