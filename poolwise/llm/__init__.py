"""Training-data operators: archives, transcripts, near and exact duplicates,
decontamination, sharding, mixing, language-model scores, token counts and
toxicity. Nothing else in the library imports this subpackage."""
