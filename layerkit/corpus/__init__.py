"""Jobs over a corpus of query texts: extraction, classification, dependencies, rules, redaction."""
