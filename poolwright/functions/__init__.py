"""Column functions: answers, text, hygiene, motifs, labels, statistics. All are native expressions."""
