"""From query text to a DataFrame: parser, model and planner."""
