"""Reading, flattening, appending, upserting and checking tables."""
