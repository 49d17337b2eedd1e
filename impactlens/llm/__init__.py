"""Training-data operators: quality, privacy, near-duplicates, packing,
language-model scoring, tokenisation, archives, chat formatting and
fingerprints. Nothing outside this subpackage imports it."""
