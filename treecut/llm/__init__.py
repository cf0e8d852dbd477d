"""Training-data pipeline operators: search, deduplication, scanning, language
identification, packing, language-model scoring, decontamination and token
counts.  Nothing outside this subpackage imports it."""
