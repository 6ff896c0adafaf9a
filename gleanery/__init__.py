"""Evidence analytics and training-data preparation as plain DataFrame -> DataFrame functions on Spark."""
