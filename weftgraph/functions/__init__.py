"""Scalar functions of the value model and of node keys."""

from weftgraph.functions.keys import composite_key, node_key, parse_literal, show_value, table_of, to_int64, valid_identifier, valid_primary_key, valid_table_id

__all__ = ["composite_key", "node_key", "parse_literal", "show_value", "table_of", "to_int64", "valid_identifier", "valid_primary_key", "valid_table_id"]
