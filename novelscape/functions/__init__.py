"""Column functions: hashing, class labels, token rules, records, tail probabilities."""
