"""Daybook: activity digests, text hygiene and their bookkeeping as Spark table operators."""
