"""Persona distillation, memory and corpus analytics on Spark DataFrames."""
