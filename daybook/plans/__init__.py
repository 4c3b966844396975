"""Chains of operators: daily digest, rendered output, maintenance, table health."""
