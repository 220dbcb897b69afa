"""Operators: functions from DataFrame to DataFrame. Clocks and seeds are arguments."""
