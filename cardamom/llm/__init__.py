"""Training-data operators: filters, joins, classifiers, sharding and tokenization for large text tables."""
