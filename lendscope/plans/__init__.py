"""The loan view over the test tables and the catalogue of registered queries."""
