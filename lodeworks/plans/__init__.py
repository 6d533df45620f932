"""Registered queries, their SQL, and the SQL front end."""
