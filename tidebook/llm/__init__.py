"""Training-data operators: archives, media, search, packing, text scans and near-duplicates."""
