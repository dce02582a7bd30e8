"""Models fitted from distributed statistics or by Spark ML."""
