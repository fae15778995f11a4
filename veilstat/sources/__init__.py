"""Reading tables and describing releases as JSON."""
