"""Training-data operators: formatting, deduplication, packing, sharding and text classifiers."""
