"""Critical-care cohort analytics expressed as PySpark DataFrame operators."""
