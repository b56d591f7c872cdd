"""Training-data operators: filtering, deduplication, decontamination and tokenising of documents."""
