"""Training-session analytics for many athletes, written as plain PySpark DataFrame operators."""
