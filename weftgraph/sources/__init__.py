"""Where graphs come from: registered tables, change logs, property layers, builders."""
