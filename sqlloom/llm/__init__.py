"""Training-data operators: packing, secrets, toxicity, chat, quality, dedup, decontamination."""
