"""Point-in-time customer features and time-to-next-purchase analysis on Spark."""
