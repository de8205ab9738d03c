"""Named queries over the tables of a folder, each beside its SQL twin."""
