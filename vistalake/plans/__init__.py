"""Named queries and the SQL they are compared with."""
