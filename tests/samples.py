"""Values that several tests share."""

SALT = "unit-test-salt-0123456789"
