"""One query per operator over the standard tables, and the SQL that it must equal."""
