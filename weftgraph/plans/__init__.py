"""The text query language: parse, bind, explain, run."""
