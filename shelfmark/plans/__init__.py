"""Input views and registered queries."""
