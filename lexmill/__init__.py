"""Legal-document analytics and text operators expressed as Spark DataFrame jobs."""
