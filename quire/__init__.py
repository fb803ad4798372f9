"""Corpus distillation analytics expressed as Spark DataFrame plans."""
