"""Search and scoring of Arabic text on Spark."""
