"""The catalogue of registered queries and the SQL that checks them."""
