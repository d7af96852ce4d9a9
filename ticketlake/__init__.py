"""ticketlake: support-ticket analytics as PySpark DataFrame jobs."""
