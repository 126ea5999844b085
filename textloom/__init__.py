"""textloom: retrieval and text analytics as DataFrame and Column functions on Spark."""
