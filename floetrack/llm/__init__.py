"""Operators of a training-data pipeline: archive, packing, language model, tokenizer, de-duplication, classifiers."""
