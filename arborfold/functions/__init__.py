"""Part of the relational web-document engine."""
