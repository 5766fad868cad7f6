"""pathlift: application-volume attribution and credit-limit analytics on Spark."""

__version__ = "0.1.0"
