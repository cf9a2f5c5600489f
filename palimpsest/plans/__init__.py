"""Registered queries: the operators applied to the stored tables, with the SQL that each equals."""
