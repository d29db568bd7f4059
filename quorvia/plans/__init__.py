"""Registered queries: survey-shaped inputs from the driver's tables, operators over them, and their SQL."""
