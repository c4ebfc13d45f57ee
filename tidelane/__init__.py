"""tidelane: timetable, demand-responsive transport and corpus analytics as Spark DataFrame jobs."""
