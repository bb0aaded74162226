"""Text and time-series analytics as composable DataFrame operators."""
