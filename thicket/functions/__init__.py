"""Part of thicket; see the README for what each module holds."""
