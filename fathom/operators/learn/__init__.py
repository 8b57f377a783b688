"""Learning a model from tables: profiles, types, fits, keys, dependencies, series and behaviour."""
