"""Conjunctive analytics over keyed, versioned tables, expressed as PySpark plans."""
